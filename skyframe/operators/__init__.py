"""Part of skyframe."""
