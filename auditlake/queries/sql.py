"""Pieces of SQL shared by the queries' counterparts."""

SPACE = r"[\s\x{000B}\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
LINE_END = r"\r\n|[\n\r\x{000B}\x{000C}\x{001C}-\x{001E}\x{0085}\x{2028}\x{2029}]"


def quoted(text: str) -> str:
    """A text as an SQL string."""
    return "'" + text.replace("'", "''") + "'"


def collapsed(column: str) -> str:
    return f"lower(trim(regexp_replace({column}, '{SPACE}', ' ', 'g')))"


def no_space(column: str) -> str:
    return f"regexp_replace({column}, '{SPACE}', '', 'g')"


def lines(table: str, text: str, *keep: str) -> str:
    """(keep..., line, raw) of every line of a text."""
    columns = ", ".join(keep)
    return f"""
SELECT {columns}, line, raw FROM (
  SELECT {columns}, unnest(parts) AS raw, generate_subscripts(parts, 1) AS line, len(parts) AS n
  FROM (SELECT {columns}, regexp_split_to_array({text}, '{LINE_END}') AS parts FROM {table} WHERE {text} IS NOT NULL)
) WHERE NOT (line = n AND raw = '')
"""


def empty(column: str) -> str:
    return f"coalesce({column}, '')"
