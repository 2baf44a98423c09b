"""Where records come from: segment directories, bytes, keystores, tables."""
