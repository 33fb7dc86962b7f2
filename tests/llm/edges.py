from __future__ import annotations


#: Texts that every operator must take: null, empty, blank, one word, ties, repeats, odd characters, a very long word.
EDGES = {0: None, 1: "", 2: " \n\t ", 3: "one", 4: "one", 5: "é 😀 ß", 6: "\\ <|end|> | \\<|", 7: "x" * 70_000, 8: "a, b. c", 9: "0 1 2 3"}


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")
