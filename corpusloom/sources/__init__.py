"""File sources: directory scans and manifests."""
