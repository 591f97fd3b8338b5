"""Training-data operators: quality, counting, dedup, decontamination, secrets, chat, HTML.

Nothing outside this folder imports it; it can be removed as a whole.
"""
