"""Readers and writers of the jobs' inputs and outputs."""
