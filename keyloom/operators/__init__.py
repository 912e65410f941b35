from keyloom.operators.aggregates import distinct_pairs, document_frequency, inverted_index, sharded_index, vocabulary_size, word_count
from keyloom.operators.mapreduce import combine_in_batches, group_reduce, map_pairs, map_reduce
from keyloom.operators.partitioners import djb2_partition, first_letter_partition, partition_by, python_partition
from keyloom.operators.sinks import write_parts, write_single

__all__ = [
    "combine_in_batches", "distinct_pairs", "djb2_partition", "document_frequency", "first_letter_partition", "group_reduce",
    "inverted_index", "map_pairs", "map_reduce", "partition_by", "python_partition", "sharded_index", "vocabulary_size", "word_count",
    "write_parts", "write_single",
]
