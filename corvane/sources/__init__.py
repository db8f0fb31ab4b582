"""File trees, tables with snapshots, and events."""
