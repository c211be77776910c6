"""Operators for large-scale training-data pipelines (text quality, deduplication,
language-model scoring, tokenisation, packing, licence scans, binary-code search).

Nothing outside this folder imports it. Shared rules for odd input:

* a NULL text counts as the empty text;
* a NULL ``doc_id`` counts as one id smaller than every other, and comes back as NULL;
* repeated rows are separate documents with the same id (every row gets its result);
* only the columns an operator names are read, so extra columns (also such that clash
  with result names) never reach a result;
* an empty table gives an empty result with the full schema.
"""
