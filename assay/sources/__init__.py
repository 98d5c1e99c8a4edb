"""Readers and writers: file trees, manifests, checkpoints, reports."""
