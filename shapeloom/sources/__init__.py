"""Reading JSON collections, manifests and schema files; writing them back."""
