from keyloom.apps.inverted_index import INVERTED_INDEX
from keyloom.apps.word_count import WORD_COUNT

APPS = {"inverted-index": INVERTED_INDEX, "word-count": WORD_COUNT}
