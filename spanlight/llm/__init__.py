"""Operators that prepare text corpora for model training.

Nothing else in the library imports this subpackage; ``__spark_entry__``
registers its queries only when it can be imported.  Operators tagged
[native] use DataFrame/SQL expressions only; the others stream Arrow batches
through numpy.  Every operator keys a row by ``(doc_id, hash of its text)`` so
that repeated ids and repeated rows are well defined, reads whole texts, and
selects its inputs by name so that extra columns never clash.
"""
