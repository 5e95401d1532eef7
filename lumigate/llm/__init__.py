"""Training-data operators: near-duplicates, classifiers, scans, mixing and binary output."""
