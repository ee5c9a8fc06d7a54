"""Profiles, statistics and text functions the rules are made of."""
