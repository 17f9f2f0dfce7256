"""Training-data operators: deduplication, decontamination, classifiers, scans, packing and chat formatting."""
