"""Archives that follow their transcripts."""
