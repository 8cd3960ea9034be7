"""File sources, format parsers and sinks."""
