"""File sources and the snapshot store."""
