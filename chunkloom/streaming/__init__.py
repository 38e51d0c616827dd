"""Structured Streaming: incremental embedding and streams of prompts."""
