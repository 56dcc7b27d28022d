"""Keyed-state graders and trackers: one small pure step function each, used in batch and stream."""
