"""Conversation diffusion analytics expressed as Spark DataFrame jobs."""
