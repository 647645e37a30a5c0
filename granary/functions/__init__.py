"""Column functions: content hashes, sizes, ids, byte ranges, access rules."""
