"""Japanese grammar in plain Python: categories and costs, built-in words, conjugation and its reverse, candidates, lemmas."""
