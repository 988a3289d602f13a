from airrline.functions.sequences import exact, hamming, levenshtein, regex

__all__ = ["exact", "hamming", "levenshtein", "regex"]
