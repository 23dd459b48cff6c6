"""Discovery, reading and writing of yearly tables."""
