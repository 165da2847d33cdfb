"""Writers for finished reports."""
