"""Writers: batches of records, tiles, index files, maps and catalogue documents."""
