"""Training-data operators: dedup, decontamination, scoring, scanning, mixing, archives."""
