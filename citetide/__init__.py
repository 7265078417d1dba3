"""Citation analytics on Spark: which genes the scientific literature talks about.

Every function takes and returns DataFrames. Reading, computing and writing are separate:

``sources``    text and table readers            ``functions``  column expressions and filters
``operators``  joins, windows, graph, layers     ``plans``      whole reports built from them
``streaming``  the daily id files as a stream    ``sinks``      writers
"""
