"""Where tensors come from and go to: the catalog, segments, importers and exporters."""
