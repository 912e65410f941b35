from keyloom.functions.hashing import djb2, djb2_mod
from keyloom.functions.text import atoi, part_name, postings_line, token_array, tokens

__all__ = ["atoi", "djb2", "djb2_mod", "part_name", "postings_line", "token_array", "tokens"]
