"""Transcript, timeline and corpus jobs as Spark DataFrame plans."""
