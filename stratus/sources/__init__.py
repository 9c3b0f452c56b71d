"""Stand-ins from the given tables, and text formats of stations and grids."""
