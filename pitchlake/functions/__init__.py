"""Part of the match-event engine."""
