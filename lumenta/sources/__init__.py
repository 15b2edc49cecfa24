"""Where vectors come from: tables, CSR batches and CSR files."""
