"""Where records come from and go to: adapters over tables, BAM files, SAM text."""
