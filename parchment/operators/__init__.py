"""DataFrame operators: joins, windows, groupings and folds over papers, files, chunks and messages."""
