"""Training-corpus operators (deduplication, extraction, scanning, filtering, mixing).

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
