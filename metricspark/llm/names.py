"""Words that tell personal names. They only detect; surrogates are drawn from lists of their own."""

from __future__ import annotations

# given names by gender; n is used for both
TABLE = {
    "f": """
Abigail Adriana Agnes Agnieszka Aisha Alejandra Alessandra Alexandra Alice Alicia Alina Allison Amanda Amélie Amina Amira Amy
Anastasia Andrea Anette Angela Angelina Anika Anita Anja Ann Anna Annabelle Anne Annette Annika Antonia Astrid Audrey Aurélie
Ayesha Barbara Beatrice Beatriz Bettina Beth Betty Beverly Birgit Bianca Brenda Bridget Brigitte Brittany Camila Camille
Carla Carmen Carolina Caroline Catalina Catherine Cecilia Chantal Charlotte Cheryl Chiara Chloe Christina Christine Cindy Claire
Clara Claudia Cláudia Cynthia Daniela Danielle Deborah Debra Denise Diana Diane Donna Doris Dorothea Dorothy Ebru Edith Elena
Eleanor Elif Elisa Elisabeth Elise Eliza Elizabeth Ella Ellen Elsa Emilia Emily Emine Emma Erika Erin Esther Eugenia Evelyn
Fatima Fatma Federica Fernanda Fiona Francesca Françoise Frida Gabriela Gabriella Gabrielle Gertrud Gillian Giorgia Giovanna
Giulia Gloria Greta Gudrun Guadalupe Hanna Hannah Heidi Heike Helen Helena Helga Hélène Hilda Hildegard Inés Inga Ingrid Irene
Irina Isabel Isabella Isabelle Jacqueline Jane Janet Janice Jean Jeanne Jennifer Jessica Joan Joanna Johanna Josephine Juana
Judith Judy Julia Juliana Julie Juliette Justyna Kamala Karen Karin Karina Katarina Katarzyna Kate Katherine Kathleen Kathryn
Katharina Katja Kavita Keiko Kelly Khadija Kimberly Kirsten Kristen Kristin Kristina Lakshmi Latisha Laura Lauren Layla Leah
Leila Lena Leticia Linda Lisa Louise Lucía Lucia Lucy Luisa Lydia Madeleine Madison Magdalena Małgorzata Manuela Margaret
Margarita Margit Maria María Mariam Mariana Marie Marina Marion Marta Martha Martina Mary Maryam Matilda Megan Mehwish
Melanie Melissa Mercedes Michelle Michiko Miranda Miriam Monica Monika Monique Nadia Nancy Naomi Natalia Natalie Natasha Nicole
Nina Noor Nora Olga Olivia Oksana Pamela Patricia Paula Pauline Petra Phoebe Phyllis Pilar Priya Rachel Raquel Rebecca Regina
Renata Renate Rita Roberta Rosa Rosalind Rosemary Ruth Sabine Sabrina Samantha Sandra Sara Sarah Sakura Samira Sanjana Selma Sharon
Sheila Shirley Silvia Simone Sofía Sonia Sonja Sophia Sophie Stacy Stefanie Stella Stephanie Susan Susanne Svetlana Sylvia
Tamara Tanya Tatiana Teresa Thelma Theresa Tiffany Tina Ulrike Ursula Uta Valentina Valeria Vanessa Vera Veronica Verónica
Victoria Virginie Wanda Wendy Wilhelmina Ximena Yasmin Yolanda Yuki Yvonne Zainab Zehra Zeynep Zofia Zoe
Александра Алина Анастасия Ангелина Валентина Валерия Вера Вероника Виктория Галина Дарья Евгения Жанна Зинаида Ирина Кристина
Ксения Лариса Лидия Маргарита Марина Надежда Наташа Нина Оксана Полина Раиса Софья Тамара Юлия
Άννα Αικατερίνη Αλεξάνδρα Αναστασία Γεωργία Ευαγγελία Ευγενία Θεοδώρα Χριστίνα Παρασκευή Σταυρούλα Φωτεινή
""",
    "m": """
Aaron Abdul Abdullah Abraham Adam Adrian Ahmad Ahmed Akira Alan Albert Alberto Alejandro Alessandro Alexander Alexandre Alexei
Alfred Alfredo Ambrose Amit Anders André Andreas Andrei Andrés Andrew Andrzej Angelo Anthony Antoine Anton Antonio António Arjun
Armando Arnold Arthur Artur Arturo Axel Barack Bartosz Benjamin Bernard Bernd Bernhard Björn Bob Boris Bradley Brandon Brian
Bruce Bruno Bryan Carlos Carsten Cédric Cesar César Charles Christoph Christophe Christopher Claude Claus Colin Craig Cristian
Cristiano Damian Daniel Daniele Danny Dariusz David Dennis Derek Diego Dieter Dietrich Dimitri Dirk Dmitri Dominik Donald Douglas
Duncan Dwight Dylan Eduardo Edward Edwin Elias Elijah Emil Emilio Emmanuel Enrique Eric Erik Ernst Esteban Ethan Étienne Eugene
Evan Fabian Federico Felipe Felix Ferdinand Fernando Filippo Florian Francesco Francis Francisco Franz Frédéric Frederick Friedrich
Fritz Gabriel Gareth Gary Gavin Geoffrey George Georg Gerald Gerard Gerhard Gianluca Gilbert Giovanni Giuseppe Gonzalo Gordon
Gregory Grzegorz Guillaume Guillermo Günter Günther Gustav Hamid Hamza Hans Harald Harold Haruki Hassan Heinrich Heinz Helmut
Henri Henry Herbert Hermann Hiroshi Horst Howard Hubert Hugo Hussein Ibrahim Ignacio Igor Ismail Isaac Ivan Jacob Jacques Jakob
Jakub James Jared Jason Javier Jeffrey Jens Jeremy Jerry Jesús Jim Joachim Joaquín Joe Joel Johan Johann Johannes John Jonas Jonathan
Jorge José Josef Joseph Joshua Juan Juha Julian Julien Julio Jürgen Justin Karl Kazuki Keith Kenji Kenneth Kevin Khalid Klaus Kofi
Konrad Konstantin Krishna Krzysztof Kumar Kurt Kwame Lars Laurent Lawrence Leon Leonard Leonardo Leonid Liam Logan Lorenzo Louis
Luc Luca Lucas Ludwig Luigi Luis Luiz Lukas Maciej Magnus Mahmoud Malcolm Manfred Manuel Marc Marcel Marcelo Marco Marcus Marek
Mario Markus Martin Mateusz Mathieu Matteo Matthew Matthias Maurice Mauricio Maximilian Mehmet Michael Michał Michel Miguel Mikhail
Mohamed Mohammad Mohammed Moritz Muhammad Murat Mustafa Nathan Nathaniel Neil Nicholas Nicolas Nikhil Nikolai Nikolaus Nils Noah
Norbert Norman Oleg Oliver Olivier Omar Oscar Oskar Otto Pablo Paolo Pascal Patrick Paul Pavel Pawel Pedro Peter Philip Philipp
Philippe Pierre Piotr Rafael Rainer Raj Rajesh Ralf Ralph Ramón Raúl Raymond Reinhard René Ricardo Riccardo Richard Robert Roberto
Rodrigo Roger Roland Rolf Roman Ronald Rubén Rudolf Rüdiger Rupert Russell Ryan Salvador Samuel Sandeep Sanjay Santiago Satoshi
Scott Sebastian Sébastien Serge Sergei Sergio Siegfried Simon Stanislav Stefan Stephan Stephen Steve Steven Stuart Sunil
Sven Takashi Takeshi Tariq Thabo Theo Theodor Theodore Thibault Thierry Thomas Thorsten Tim Timothy Tobias Todd Tom Tomás Tomasz
Torsten Udo Ulrich Uwe Vikram Vincent Vincenzo Vladimir Volker Walter Wayne Werner Wilhelm William Winston Wojciech Wolfgang Xavier
Yannick Yusuf Yves Zachary Александр Анатолий Антон Артём Богдан Борис Вадим Валерий Василий Виктор Виталий Вячеслав Геннадий Георгий
Григорий Даниил Денис Егор Игорь Кирилл Константин Леонид Максим Никита Олег Пётр Роман Руслан Семён Станислав Степан Тимофей
Фёдор Ярослав Αλέξανδρος Ανδρέας Άγγελος Γεώργιος Γρηγόρης Ευάγγελος Θανάσης Θεόδωρος Ιωάννης Κωνσταντίνος Μιχάλης Νικόλαος
Πέτρος Σπύρος Σταύρος Στέφανος
""",
    "n": "Alexis Ashley Cameron Casey Dominique Jamie Kerry Lesley Leslie Marley Morgan Robin Sasha Shannon Tracy",
}
# words with other uses: names only before another capitalised word, as also family names that stand first
BEFORE_A_NAME = {
    "f": "Amber Ana Autumn Carol Crystal Daisy Dawn Eva Faith Florence Georgia Grace Hazel Heather Holly Hope Ida Iris Ivy Jasmine Joy Lily Mei Olive Paris Penny Rose Ruby Sofia Sue Summer Virginia Mia Ava Ines",
    "m": "Ali Austin Ben Bill Chad Christian Clay Dan Dean Don Earl Frank Glen Grant Ian Jack Jan Jay Jordan Leo Luke Mark Max Miles Nick Pierce Ray Rob Ron Sam Sean Tony Victor Wade Levi Omer Jun Hao Ivo Kai Max Karl-Heinz Ned Ted",
    "n": "Alex Angel Chris Dale Drew Jo Kim Lee Li Pat Taylor Terry Wei Xin Yu Ming Ling Min Chen Wang Zhang Liu Yang Huang Zhao Wu Zhou Xu Zhu Guo Lin Gao Luo Zheng Liang Xie Tang Feng Deng Cao Peng Zeng Xiao Tian Dong Pan Yuan Cai Jiang Ye Park Choi Jung Kang Cho Yoon Jang Lim Han Nguyen Tran Pham Hoang Phan Vu Dang Bui Ngo Tanaka Suzuki Sato Watanabe Yamamoto Nakamura Kobayashi",
}
# what may stand between a given name and a surname, and stays
PARTICLES = "de da das del della den der di do dos du el al bin ibn la le ten ter van von zu"
# capitalised words that are no part of a name
OTHERS = """
A About After All Also Am An And Are As At Be Because Before But By Can Could Day Did Do Does During For From Had Has Have He Her His
How I If In Into Is It Its May Must My No Not Now Of On Or Our Out She Should So That The Their Then There These They This Those To Was We
Were What When Where Which While Who Why Will With Would You Your Monday Tuesday Wednesday Thursday Friday Saturday Sunday January
February March April June July August September October November December Street Road Avenue University College Hospital School Church
Der Die Das Den Dem Ein Eine Er Es Sie Und Oder Aber Im Am Zu Von Mit Für Auf Ist War Le La Les Un Une Et Est Il Elle El Los Las Una Y En
В На И Он Она Они Но Это Как Что По Из За От Ο Η Το Οι Τα Και Στο Στη
"""
