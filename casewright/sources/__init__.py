"""Reading corpora, writing result tables, manifests and snapshots."""
