"""A Spark-native engine of sketch, placement, codec, stream and training-data operators."""
