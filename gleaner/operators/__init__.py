"""DataFrame operators: matching, cell metrics, statistics, flattening, ranking, topics, papers, sections, tasks."""
