"""What is made of results: texts, tables, graphs and reads."""
