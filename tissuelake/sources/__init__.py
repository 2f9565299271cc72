"""Readers and writers: pyramidal images, text inputs, the feature store and exports."""
