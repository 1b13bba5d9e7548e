"""Relational operators over candidates, trials and training problems."""
