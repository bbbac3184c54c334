"""Storage: a commit log of manifests over immutable Parquet segments."""
