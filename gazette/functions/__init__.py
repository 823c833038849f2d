from gazette.functions.text import (compose_text, keyword_hits, py_len_sum, str_array, trim_ws,  # noqa: F401
                                    word_count, words)
from gazette.functions.vectors import cosine, dot, norm, to_double  # noqa: F401
