"""Sources: test tables, RLP decoding."""
