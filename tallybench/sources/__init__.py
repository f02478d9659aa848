"""Readers and writers: split files, matrices, descriptors, metric files, logs."""
