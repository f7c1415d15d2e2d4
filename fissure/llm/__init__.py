"""Training-data preparation: thirteen operators over documents, pages, embeddings and conversations."""
