"""Token sizes of documents by a public tokenizer."""
import os

import pandas as pd
from pyspark.sql import DataFrame

TOKENIZER = "byte_bpe_50k.tiktoken"  # a file of the installed public vocabularies, or any path
_made = {}


def _encoding(path):
    if path not in _made:
        import base64

        import public_tokenizers
        import tiktoken
        file = path if os.path.isabs(path) else public_tokenizers.path(path)
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(file, "rb"))}
        _made[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _made[path]


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, source, tokens of the whole text; a null or empty text has 0."""
    def run(batches):
        enc = _encoding(path)
        for d in batches:
            yield pd.DataFrame({"doc_id": d.doc_id, "source": d.source, "tokens": [len(enc.encode_ordinary(t)) if isinstance(t, str) else 0 for t in d.text]})
    return documents.select("doc_id", "source", "text").mapInPandas(run, "doc_id bigint, source string, tokens bigint")
