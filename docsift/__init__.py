"""docsift: document-corpus indexing, search and analytics as Spark jobs.

Every operator is a function from DataFrames to a DataFrame, built from
built-in column expressions so Catalyst can push filters, prune columns and
keep the work inside whole-stage codegen.  Sub-packages:

* ``functions`` - column expressions (paths, ids, formatting, tokens, tags)
* ``operators`` - relational operators (search, facets, full text, vectors,
  tags, incremental snapshots, rules, windows, treemap)
* ``sources``   - table loading, derived fixtures, file listings, sinks
* ``plans``     - the query registry used by ``__spark_entry__`` and bench
* ``streaming`` - Structured Streaming upserts of documents and tag edits
"""

__version__ = "0.1.0"
