"""Part of the edgewise engine."""
