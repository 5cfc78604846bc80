"""Training-data operators: deduplication, scoring, filtering, scanning and packing of documents.

Nothing else in the library imports this subpackage. Conventions shared by all its operators:

* input is a DataFrame with an id column and a text column; every other column is ignored, so extra
  columns may have any name;
* a NULL text is the empty text, a NULL id stays a NULL id, repeated rows are scored row by row;
* an empty table gives an empty result with the same schema.
"""
