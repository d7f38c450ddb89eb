"""Texts shared by the tests of this folder."""

#: Texts that every operator must take: null, empty, blank, short, repeated, long, odd characters.
EDGES = [None, "", "   \n\t", "one", "two words", "same text here", "same text here", "a b c d e f g h " * 3000, "é  x\x1cy 日本 \U0001f600", "\n\n\n", "!!! ### $$$", "same  text\there"]
