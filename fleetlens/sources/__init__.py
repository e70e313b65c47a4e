"""File sources, tables and sinks."""
