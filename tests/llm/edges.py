#: Nulls, an empty text, one long text, copies, a repeated row, and a text without words.
EDGES = [(1, None), (2, ""), (3, "a b c d e f g"), (4, "a b c d e f g"), (4, "a b c d e f g"), (None, "no id here"), (5, "word " * 30_000), (6, " \n\t "), (7, "ä😀 <|endoftext|> x"), (8, "one")]
