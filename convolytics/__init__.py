"""Conversation-tutoring analytics as Spark DataFrame and streaming jobs."""
