"""Part of the veridict engine."""
