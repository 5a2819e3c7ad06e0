"""Part of pagewright; see the package README."""
