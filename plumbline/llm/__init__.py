"""Training-data operators: archives, vectors, extraction, classifiers, near-duplicates, tokens, mixing."""
