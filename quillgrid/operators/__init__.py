"""DataFrame operators from raw rows to scored predictions."""
