"""Part of the data-contract analytics engine."""
