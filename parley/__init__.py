"""Conversation and speaker analytics as Spark jobs."""
