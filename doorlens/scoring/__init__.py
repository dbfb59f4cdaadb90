"""The score contract: evidence rows whose points add up to the score."""
