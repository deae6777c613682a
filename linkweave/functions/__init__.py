"""Part of linkweave; see the package README."""
