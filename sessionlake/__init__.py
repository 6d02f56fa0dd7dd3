"""Conversation transcripts to a searchable knowledge and decision record, on Spark."""
