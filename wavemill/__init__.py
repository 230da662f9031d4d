"""wavemill: framed signals, scores, embeddings and the text derived from them, as Spark DataFrames."""
