"""Analytics over FASTQ sequencing reads, built on Spark DataFrames."""
