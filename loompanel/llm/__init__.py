"""Training-data operators: sharding, deduplication, scoring, tokenising, extraction, decontamination.

Every operator takes and returns DataFrames.  Nothing outside this subpackage imports it.

Shared conventions, unless an operator's docstring says otherwise:

* a null text counts as the empty text; a null id is carried through like any other value;
* repeated rows are kept: one result row for each input row;
* an empty table gives an empty result with the same schema;
* operators that describe documents return the id column and their own columns and read no other
  column, so extra input columns, whatever their names, cannot clash; filters return exactly the
  input columns and use only helper names that start with ``__lp_``.
"""
