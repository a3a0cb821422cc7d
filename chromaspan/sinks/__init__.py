"""Writers: tab-separated tables, the binary matrix, and run metadata."""
