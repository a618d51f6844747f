"""Landed source files to typed records. Fetching is outside: everything starts from files or columns already landed."""
