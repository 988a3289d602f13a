"""Plan building blocks: materialisation, dense ids, null-safe joins."""
