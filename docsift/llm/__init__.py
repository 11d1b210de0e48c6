"""Training-data operators: mixing, LM scoring, packing, nearest neighbours,
suffix-array dedup, toxicity, embedding and SimHash near-dedup, token counts,
WARC archives, centroid clustering, spelling variants and exact top-k search.
Nothing outside this package imports it."""
