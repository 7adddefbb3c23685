"""Column expressions: ABI words, 256-bit integers, decoding and encoding."""
