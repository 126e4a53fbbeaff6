"""Batch and streaming operators for labelled event and utterance corpora, as DataFrame functions."""
