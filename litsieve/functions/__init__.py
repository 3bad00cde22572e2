"""Part of the screening plans."""
