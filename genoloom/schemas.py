"""Schemas of the tables between operators, as DDL."""

SAMPLES = "sample_ord long, sample_id string, gff_file string, assembly string"
GENE_ANNOTATION = "ann_ord long, gene_id string, sample_id string, seq_id string, length int, gene_name string, gene_product string, gene_index int, strand string"
GENE_POSITION = "sample_id string, seq_id string, pos int, gene_id string"
GENE_SEQ = "seq_ord long, gene_id string, sample_id string, nt string, aa string"
HITS = "qseqid string, sseqid string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double, qlen int, slen int"
MEMBERSHIP = "cluster_idx long, member_ord long, gene_id string"
FAMILIES = "family_ord long, name string, gene_ids array<string>, product string, representative string, min_length int, max_length int, mean_length double, size long"
