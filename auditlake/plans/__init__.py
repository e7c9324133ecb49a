"""Plan building blocks: session, durable intermediate tables, skew-aware joins."""
