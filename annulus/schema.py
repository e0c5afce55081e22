"""Schemas of the relations, declared once."""

RAW = "ord long, chrom string, pos long, id string, ref string, alt array<string>, qual string, filter string, info map<string,string>, samples array<map<string,string>>"
SV = "ord long, sv_id string, chr1 string, pos1 long, chr2 string, pos2 long, svtype string, svlen long, strand string, dv long, dr long, gt string, secondary boolean, mate string, error string"
COVERAGE = "chr string, start long, end long, value double"
CHROM = "chr string, length long"
READ = "name string, chr string, ref_start long, ref_end long, query_length long, is_mapped boolean, is_secondary boolean"
GENOME = "chr string, seq string"
FRAGMENT = "fid long, chr string, start long, end long, tail long, head long, edge_id long, coverage double, len double"
EDGE = "edge_id long, u long, v long, svtype int, weight double"
GRAPH_SPEC = "node1 long, node2 long, frag1 string, frag2 string, part1 int, part2 int, edgeid long, svtype int, cov double"
TRUTH_BED = "chr string, start long, stop long, direction string, target string, coverage double, structure string, fragment string"
CIRCLE_BED = "chr string, start long, end long, circ_id string, fragment_id string, strand string, coverage double, estimated_proportions double"
HITS = "qseqid string, sseqid string, pident double, alignment_length long, number_mismatches long, number_gap_openings long, query_start long, query_end long, subject_start long, subject_end long, evalue double, bitscore double"
