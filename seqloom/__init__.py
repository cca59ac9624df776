"""seqloom: Spark-native sequence retrieval, alignment, decoding and corpus engineering."""
