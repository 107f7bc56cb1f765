"""Part of strataloom; see the modules for the operators."""
